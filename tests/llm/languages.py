"""Clean text in many languages."""

#: The first article of the Universal Declaration of Human Rights, or a plain sentence, in languages that the tables don't hold.
MORE_CLEAN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. Łódź jest pięknym miastem w Polsce. Zażółć gęślą jaźń.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Příliš žluťoučký kůň úpěl ďábelské ódy.",
    "sk": "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Kŕdeľ šťastných ďatľov učí pri ústí Váhu mĺkveho koňa obhrýzať kôru.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Egy szép őszi napon árvíztűrő tükörfúrógép zúgott.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Vrem să învățăm această limbă. Ele sînt înzestrate cu rațiune şi conştiinţă. ÎNVĂŢĂMÂNTUL ÎN ŢARĂ",
    "hr": "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Šta radiš večeras? Čovjek ječi pored žice.",
    "sl": "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Piškur molče grabi fižol z dna cezijeve hoste.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Çağlar şöyle dedi: İstanbul güzel. Pijamalı hasta yağız şoföre çabucak güvendi.",
    "az": "Bütün insanlar ləyaqət və hüquqlarına görə azad bərabər doğulurlar. Onların şüurları və vicdanları var.",
    "lt": "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Įlinkdama fechtuotojo špaga sublykčiojusi pragręžė apvalų arbūzą.",
    "lv": "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Glāžšķūņa rūķīši dzērumā čiepj Baha koncertflīģeļu vākus.",
    "et": "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Põdur Zagrebi tšellomängija-följetonist Ciqo külmetas kehvas garaažis. Öö oli ö ja õ.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Törkylempijävongahdus. Wieniläinen žurnalisti šakkasi.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. På en ö i en å bor en räv. Flygande bäckasiner söka hwila på mjuka tuvor.",
    "no": "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. Æ e i A æ å. Vår sære Zulu fra badeøya spilte jo whist.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. Høj bly gom vandt fræk sexquiz på wc. Ø og å.",
    "is": "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Kæmi ný öxi hér, ykist þjófum nú bæði víl og ádrepa. Það er þýðing.",
    "nl": "Alle mensen worden vrij en met gelijke rechten geboren. Één coördinator reünieerde de zeeën; geëerd, naïef.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Perché così è più virtù, là e lì. È già così!",
    "ca": "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. El col·legi és paral·lel; açò són llengües.",
    "ga": "Saolaítear gach duine den chine daonna saor agus comhionann i ndínit agus i gcearta. An bhfuil Éire fós ann?",
    "cy": "Genir pawb yn rhydd ac yn gydradd â'i gilydd mewn urddas a hawliau. Mae'r tŷ ger y dŵr; sŵn gwynt a glaw â thân.",
    "sq": "Të gjithë njerëzit lindin të lirë dhe të barabartë në dinjitet dhe në të drejta. Ç’është kjo? Çdo ditë.",
    "mt": "Il-bnedmin kollha jitwieldu ħielsa u ugwali fid-dinjità u d-drittijiet. Ġurnata sabiħa, żmien ċar.",
    "eo": "Ĉiuj homoj estas denaske liberaj kaj egalaj laŭ digno kaj rajtoj. Eĥoŝanĝo ĉiuĵaŭde.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Đã là người Việt Nam thì ai ấy cũng biết. Ở ô à ù.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ΤΟ ΚΕΙΜΕΝΟ ΜΕ ΚΕΦΑΛΑΙΑ.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. УКРАЇНА, ЇЖАК І ҐАНОК. Щастя б’є джерелом.",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. ВСИЧКИ ХОРА СЪЩО ЩЪКАТ.",
    "sr": "Сва људска бића рађају се слободна и једнака у достојанству и правима. ЉУБАЗНИ ФЕЊЕРЏИЈА ЧАЂАВОГ ЛИЦА.",
    "mk": "Сите човечки суштества се раѓаат слободни и еднакви по достоинство и права. ЌЕ ДОЈДЕ ЅВЕЗДА, ЅИД И ЊЕГОВ.",
    "be": "Усе людзі нараджаюцца свабоднымі і роўнымі ў сваёй годнасці і правах. УСЕ ЛЮДЗІ Ў БЕЛАРУСІ.",
    "kk": "Барлық адамдар тумысынан азат және қадір-қасиеті мен құқықтары тең болып дүниеге келеді. ҚАЗАҚСТАН ӨҢІРІ.",
    "mn": "Хүн бүр төрж мэндлэхдээ эрх чөлөөтэй, адилхан нэр төртэй байдаг. МОНГОЛ УЛСЫН ҮНДЭСНИЙ ӨВ.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. ה-API של Python עובד.",
    "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً.",
    "fa": "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند.",
    "ur": "تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔",
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით.",
    "hy": "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 韓國의 漢字와 大韓民國 국민.",
    "bn": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে।",
    "ta": "மனிதப் பிறிவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர்; அவர்கள் மதிப்பிலும், உரிமைகளிலும் சமமானவர்கள்.",
    "am": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው።",
    "km": "មនុស្សទាំងអស់ កើតមកមានសេរីភាព និងសមភាព ក្នុងផ្នែកសេចក្ដីថ្លៃថ្នូរនិងសិទ្ធិ។",
    "my": "လူတိုင်းသည် တူညီ လွတ်လပ်သော ဂုဏ်သိက္ခာဖြင့် လည်းကောင်း၊ တူညီလွတ်လပ်သော အခွင့်အရေးများဖြင့် လည်းကောင်း၊ မွေးဖွားလာသူများ ဖြစ်သည်။",
    "zh-Hant": "人人生而自由，在尊嚴和權利上一律平等。他們賦有理性和良心，並應以兄弟關係的精神相對待。龜鬱麤灩",
    "yo": "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba.",
    "mi": "Ko te katoa o nga tangata i te whānaunga mai e wātea ana i ngā here katoa; ko te reo Māori tēnā.",
    "pinyin": "Rénrén shēng ér zìyóu, zài zūnyán hé quánlì shàng yīlǜ píngděng. Nǐ hǎo ma?",
    "iast": "Oṃ namaḥ śivāya; saṃskṛta and Ṛgveda, Kṛṣṇa, ācārya, ñāṇa, Pāṇini.",
    "maths": "x² + y³ ≤ 10 µm; Δx ≥ ħ/2, √x ≈ 2πr, αβγ, f→g, a≤b, σ² = ∑(x−µ)², kΩ, Ωm, 5 µF, ∂u/∂t, ∆x, ƒ(x), €5, ½ cup, 20 °C, N·m, kg·m², m²K, word¹, H₂O, λx.x, 100‰",
    "names": "Wałęsa met Dvořák, Škoda, Čapek, Erdoğan, Gödel, Erdős, Ångström, Žižek, Brâncuși, Håkon and Nguyễn in Łódź; señor Peña flew to Curaçao, São Paulo and Reykjavík. Beyoncé, Motörhead, McÉwan.",
}
